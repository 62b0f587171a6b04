"""tessella: feature tables on PySpark.

Modules:

* ``tessella.functions``: Column functions: ``geometry`` (struct geometry,
  predicates, validity, repair, reprojection, CRS, extents), ``names``,
  ``types``.
* ``tessella.operators``: DataFrame operators: ``query``, ``quality``,
  ``profile``, ``cdc``, ``spatial``, ``joins``, ``mapping``, ``catalog``.
* ``tessella.sources``: ``readers``, ``sinks``, ``layers`` (layers derived
  from the benchmark tables).
* ``tessella.streaming``: ``sync`` (foreachBatch sync), ``keyed`` (per-key
  change classification in the streaming state store).
* ``tessella.plans``: ``layers`` (import and transform lifecycles),
  ``manifest`` (export items).
* ``tessella.session``: session defaults, checkpoint folder, table loading.
"""

"""Training-data operators over web-scale text: de-duplication, quality,
toxicity, decontamination, extraction and packing.

Nothing outside this subpackage imports it. ``queries.QUERIES`` holds the
registered ``opN_<name>`` queries, ``queries.ORACLE`` their DuckDB twins.
"""

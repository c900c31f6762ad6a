"""Training-data operators (ANN search, extraction, filtering, dedup, packing, formatting).

Nothing outside this subpackage imports it. ``queries.QUERIES`` / ``queries.ORACLES`` hold the
driver's queries; each operator module has its own general interface.
"""

"""quarry: a Spark-native retrieval engine for code and documents.

Entry points (all ``DataFrame -> DataFrame`` functions):

* ``quarry.sources.files``: ``from_table``, ``from_binary_files``, ``from_tree``,
  ``select_source_files``, ``decode_content``, ``discover_projects``;
* ``quarry.operators.structure``: ``structured_chunks``, ``build_chunks``, ``with_search_text``;
* ``quarry.operators.embed``: ``hashed_embedding``, ``model_embedding``, ``attach_vectors``,
  ``embed_unique_texts``;
* ``quarry.operators.index``: ``refresh_projects``, ``index_projects``, ``read_index``,
  ``drop_projects``, ``index_summary``;
* ``quarry.operators.search``: ``search``, ``compact_results``;
* ``quarry.operators.registry``: ``upsert_projects``, ``stamp_indexed``, ``remove_projects``,
  ``lookup``, ``list_projects``, ``load_registry_json``;
* ``quarry.streaming.query_stream``: ``answer_query_stream``.

Nothing is imported here, so Python workers unpickling a UDF load only the module they need.
"""

__version__ = "0.1.0"

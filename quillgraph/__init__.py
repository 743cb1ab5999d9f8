"""quillgraph: a PySpark-native engine for hybrid knowledge-graph and vector retrieval over document corpora."""

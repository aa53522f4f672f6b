"""tesselkg: knowledge-graph retrieval, recommendation analytics and training-data operators on PySpark."""

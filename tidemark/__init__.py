"""tidemark: live relational queries, change data and row patches on PySpark."""

"""A Spark-native engine for genomic signal analytics and training-data preparation.

Subpackages: ``sources`` (readers and writers), ``functions`` (column
expressions), ``operators`` (DataFrame in, DataFrame out), ``plans``
(composed pipelines and the query catalogue), ``streaming`` (Structured
Streaming forms).  ``llm`` holds the operators for language-model training data;
nothing outside that subpackage imports it.
"""

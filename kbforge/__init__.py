"""kbforge: question-answer knowledge-base pipelines expressed as Spark jobs.

Sub-packages
------------
sources    readers and writers (lenient CSV, parquet, nested result files)
functions  column expressions (text cleaning, templates, vectors)
operators  DataFrame operators (relational steps, kNN search, IVF, answer assembly,
           evaluation, history)
plans      end-to-end jobs (curate, index, ask) and the registered query catalog
streaming  Structured Streaming versions of index load, ask and request metrics
"""

__version__ = "0.1.0"

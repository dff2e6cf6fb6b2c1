"""ragtide: retrieval-augmented question answering as Spark DataFrame jobs.

Layout
- ``sources``   corpus files, testdata tables, the passage store
- ``functions`` column-expression helpers and small per-row helpers
- ``operators`` DataFrame -> DataFrame operators (chunk, embed, kNN, rerank, fuse, ...)
- ``plans``     composite jobs (index, retrieve, answer, compare, evaluate)
- ``streaming`` Structured Streaming versions of the question and corpus jobs
"""

from ragtide.config import RagOptions

__all__ = ["RagOptions"]

"""skein — Spark jobs for preparing and scoring post-training data.

Sub-packages:
  functions/  column expressions (text checks, numeric rewards, vectors)
  sources/    readers, sinks and the fixture tables derived from the inputs
  operators/  the jobs: pairs, embeddings, scoring, prompts, rewards, ledger,
              votes, metrics, reports
  plans/      the registered query catalogue and its DuckDB oracle twins
  streaming/  Structured Streaming twins of the reward and ledger jobs
"""

__version__ = "0.1.0"

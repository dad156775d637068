"""txsentinel: transaction anomaly analytics on Spark DataFrames.

Layers:
  sources/    readers, validators, adapters, sinks
  functions/  column expressions (features, hashing, flags)
  operators/  distributed operators (features, ordered ops, profiling,
              injection, evaluation, detectors)
  plans/      end-to-end flows composed from operators
  streaming/  Structured Streaming scoring and online velocity state
"""

from txsentinel.session import get_session, materialize

__all__ = ["get_session", "materialize"]

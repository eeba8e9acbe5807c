"""Structured Streaming jobs.

Every query writes to a file sink with a checkpoint location under the
shared checkpoint root, so a restarted or partially failed run resumes
exactly-once; ``foreachBatch`` writers overwrite their own
``batch_id=N`` folder, so a replayed batch is idempotent.
"""

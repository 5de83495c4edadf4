"""No operator here: the job has no unbounded source. Incremental work is batch: append and keyed upsert in ``sources.sinks``."""

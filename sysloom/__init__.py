"""Package-threat analytics on Spark: syscall traces, package sources, registry
snapshots and lockfiles in; findings, verdicts and report tables out."""

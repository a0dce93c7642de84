"""Tables in and out: labels, results, manifests and reports, by Spark's own readers and writers."""

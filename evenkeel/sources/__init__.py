"""Reading and writing: JSON artifacts, trace shards, verified snapshots and seeded tables."""

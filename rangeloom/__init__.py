"""Life-cycle of range-partitioned tables on Spark: adopt, grow, constrain, scan, detach and drop."""

"""Column-level building blocks: missing values, dates, label recodes, the t distribution."""

"""Public-statistics KPI analytics as composable Spark DataFrame functions."""

"""sparkloom: analytics over sourced knowledge graphs, written Spark-first."""

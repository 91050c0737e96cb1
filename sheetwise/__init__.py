"""sheetwise: a Spark-first engine for snapshots of technical drawings and similar documents."""

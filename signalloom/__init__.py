"""signalloom: turn tables and streams of raw text items into ranked company signals on Spark."""

"""shelfweave: Spark jobs for demand panels (daily unit sales per store and item)."""

"""Reading and writing: configurations, papers, results, manual tables, catalog tables, reports."""

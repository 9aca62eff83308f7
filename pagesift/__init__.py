"""pagesift: DataFrame jobs that turn a stored web-page corpus into a searchable index."""

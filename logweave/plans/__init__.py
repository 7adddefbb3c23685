"""Query surface: structured queries, raw SQL, entity views, batch jobs."""

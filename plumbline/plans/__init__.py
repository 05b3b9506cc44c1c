"""The query catalogue: every operator as a query over the shared tables, with its check SQL where one exists."""

"""Sources: inbox files, pages, reference tables, and views of the driver's tables."""

"""Column -> Column functions; nothing in here starts a job."""

"""Column functions: presence, text, numbers, identity and labels. Nothing here starts a job."""

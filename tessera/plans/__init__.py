"""What is decided before a query runs: which lane reads a document, and how many times."""

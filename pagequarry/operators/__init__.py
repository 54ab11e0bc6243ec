"""Row-wise and relational operators over pages and links."""

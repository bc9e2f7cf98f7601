"""Table definitions and fixed wording."""

"""Relational building blocks: joins that survive hot keys, numbering, rules."""

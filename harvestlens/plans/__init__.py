"""The registered queries, their derived inputs and their SQL twins."""

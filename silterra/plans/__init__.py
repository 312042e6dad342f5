"""Registered queries and the SQL that states what each of them computes."""

"""Registered queries: each builds one plan over the tables of a folder."""

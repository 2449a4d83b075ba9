"""Registered queries by area, each with the SQL that it is compared with."""

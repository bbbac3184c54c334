"""Operators on collections: relations, change tracking, conflicts, attachments and migrations."""

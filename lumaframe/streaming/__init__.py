"""Additions beyond single images: folders that are watched."""

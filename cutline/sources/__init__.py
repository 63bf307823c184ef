"""Readers and writers: wide and keyed CSV, JSON artifacts, marked-up text, glyph tables, snapshots and audit rows."""

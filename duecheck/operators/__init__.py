"""Operators: extraction, checks, detection, findings, scoring, memos, reports."""

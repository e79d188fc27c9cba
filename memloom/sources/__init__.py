"""Readers for tables, markdown trees and JSONL transcripts."""

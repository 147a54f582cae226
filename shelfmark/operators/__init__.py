"""Operators: reconcile, rules, parsing, linkage, identity, planning, audits."""

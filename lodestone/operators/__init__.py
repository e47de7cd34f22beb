"""Declarative DataFrame operators: rules, references, comparison, versions, redaction, geometry."""

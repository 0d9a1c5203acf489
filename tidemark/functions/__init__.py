"""Column builders: plain functions from columns to columns, so everything stays inside generated code."""

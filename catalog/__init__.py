"""Registered queries over the test tables, each with an oracle statement."""

"""Registered queries over the test tables, each with its DuckDB SQL."""

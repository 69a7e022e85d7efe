"""Whole queries: mining, sweeps, views, and the registered queries."""

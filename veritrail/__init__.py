"""Veritrail: evidence auditing and corpus preparation, planned by Catalyst."""

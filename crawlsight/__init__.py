"""Site-audit analytics on Spark: pages in, rules, link graph and reports out."""

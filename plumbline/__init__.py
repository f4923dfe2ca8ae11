"""Table quality checks as Spark DataFrames.

``plans``      the closed list of rule types, and turning one rule into Column expressions
``functions``  Column helpers: rule identity, rendered sentences, type and regex vocabularies
``operators``  suites, samples, profiles, audits, the rule registry, lint, run history
``sources``    table listing, scans, and the append-only rule and run tables
``streaming``  one verdict at a time
"""

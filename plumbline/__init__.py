"""Evidence-first analytics on Spark: profile, cell cube, tests, discovery, analyses, ledger."""

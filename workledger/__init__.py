"""A Spark engine over the exhaust of language-model agents: events, identity links and relations as tables;
accounting, attribution, detectors, evaluation and findings as DataFrame projections over them."""

"""From questions in English to operators, and the queries that the driver runs."""

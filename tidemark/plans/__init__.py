"""Plan building blocks: staged tables, exact positions, blocked prefix sums."""

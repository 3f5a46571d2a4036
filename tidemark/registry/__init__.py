"""Named queries over the driver tables, each with its SQL where SQL can say it."""

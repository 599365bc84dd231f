"""Named queries over the driver's tables, each with its operators' ids and, where SQL can say it, an oracle."""

"""Named queries over the test tables, with SQL for those that SQL can express."""

"""Views of the test tables in the data model, and the registered queries with their SQL."""

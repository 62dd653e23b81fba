"""The registered queries, each with the SQL that it equals."""

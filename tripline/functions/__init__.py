"""Column functions: text, collections, time and geography. All are built-in expressions that Catalyst can see through."""

"""Planning: registered queries and the catalog compiler."""

"""Reading and writing panels: facts, events, columns, documents and libraries of computed cells."""

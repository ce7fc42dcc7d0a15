"""Tables, files, documents and their listings."""

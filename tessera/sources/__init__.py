"""Tables, file layout and write-ahead-log segments."""

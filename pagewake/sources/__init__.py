"""Table readers and the views the operators run on."""

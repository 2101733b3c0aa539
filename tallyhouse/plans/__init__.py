"""Reports: operators composed into the tables a reader asks for."""

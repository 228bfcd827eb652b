"""Jobs that run on their own: each has a command line and a config file, and reads and writes through Spark only."""

"""Jobs that can be run from the command line. Each has a function run() that takes a session."""

"""Table and stream operators for running a fleet of databases and hosts from their data."""

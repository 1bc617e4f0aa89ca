"""Every job bound to the generated test tables, with the SQL to compare it with."""

"""Column functions: labels, calendar, guards."""

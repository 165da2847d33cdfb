"""The three returns: fees, rent and payroll."""

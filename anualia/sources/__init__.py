"""Readers: fee reports (HTML), payroll books (CSV), rental sheets."""

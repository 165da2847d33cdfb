"""Annual sworn returns (fees, rented real estate, payroll) as Spark jobs."""

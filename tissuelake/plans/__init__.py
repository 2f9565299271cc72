"""Planning on the driver: requests, geometry, resume, conformance, cohorts and runs."""

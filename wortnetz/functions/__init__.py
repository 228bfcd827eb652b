"""Column expressions; none of them needs Python on the executors unless it says so."""

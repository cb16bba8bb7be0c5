"""Web-content analytics and quality assurance on PySpark."""

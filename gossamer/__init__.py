"""gossamer: finding, reviewing and anonymising personal data in text tables, as Spark DataFrame expressions."""

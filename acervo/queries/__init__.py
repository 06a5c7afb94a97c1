"""The query catalogue: name -> callable(spark, sf_dir), and its SQL where SQL can say it."""

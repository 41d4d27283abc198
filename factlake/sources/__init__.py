"""Files and tables read and written."""

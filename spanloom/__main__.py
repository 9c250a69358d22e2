from .api import main

main()
